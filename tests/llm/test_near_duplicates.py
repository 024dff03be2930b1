import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import line_dedup as L
from textloom.llm import queries
from textloom.llm import simhash as S
from textloom.llm.components import connected

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def unite(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


@pytest.mark.parametrize("text", [None, "", "  ", "A b", "One TWO three four", "a b c d e É", "x " * 5000, "a b c\x0bd e f g"])
def test_fingerprint_equals_brute_force(text):
    assert S.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize(("rows", "least"), [(4, 50), (40, 8), (10**6, 0)])
def test_trees_find_every_pair(monkeypatch, rows, least):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 150).astype(np.uint64) * np.uint64(2)
    near = [centres]
    for k in range(1, 7):
        moved = centres.copy()
        for _ in range(k):
            moved ^= np.uint64(1) << rng.integers(0, 64, len(moved)).astype(np.uint64)
        near.append(moved)
    tight = centres[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([*near, tight])).view(np.int64)
    monkeypatch.setattr(S, "SHARD_ROWS", rows)
    place, found = {int(x): i for i, x in enumerate(fp)}, Groups(len(fp))
    trees = S.grow(fp[::3].copy(), len(fp))
    for row, shard, owned in S.places(fp, trees):
        assert owned.sum() >= len(fp) and len(np.unique(shard)) > least
        for n in np.unique(shard):
            for a, b in zip(*S.shard_links(fp[row[shard == n]], owned[shard == n]), strict=True):
                found.unite(place[int(a)], place[int(b)])
    wanted, bare = Groups(len(fp)), fp.view(np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(bare ^ bare[i]) <= 4):
            wanted.unite(i, int(j))
    assert [found.find(i) for i in range(len(fp))] == [wanted.find(i) for i in range(len(fp))]


def group_and_satellites(seed, members, satellites, others):
    """Fingerprints within 4 bits of each other, more that are one bit a quarter off one of them, and random ones."""
    rng = np.random.default_rng(seed)
    bit = lambda n, low=0, high=64: np.uint64(1) << rng.integers(low, high, n).astype(np.uint64)
    group = np.uint64(rng.integers(0, 2**63)) ^ bit(members) ^ bit(members)
    off = group[rng.integers(0, members, satellites)]
    for q in range(4):
        off = off ^ bit(satellites, 16 * q, 16 * q + 16)
    return np.unique(np.concatenate([group, off, rng.integers(0, 2**63, others).astype(np.uint64)])).view(np.int64)


def roots_of(fp, owned):
    """Components of pairs within 4 bits of which at least one is owned, each pair compared."""
    groups, bare = Groups(len(fp)), fp.view(np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero((np.bitwise_count(bare ^ bare[i]) <= 4) & (owned | owned[i])):
            groups.unite(i, int(j))
    return [groups.find(i) for i in range(len(fp))]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 0.9, 1.0])
def test_visitors_meet_owned_members_of_the_largest_component(share):
    rng = np.random.default_rng(6)
    for seed in range(12):
        fp = rng.permutation(group_and_satellites(seed, 60, 150, 40))
        owned = rng.random(len(fp)) < share
        found, place = Groups(len(fp)), {int(x): i for i, x in enumerate(fp)}
        for a, b in zip(*S.shard_links(fp, owned), strict=True):
            found.unite(place[int(a)], place[int(b)])
        assert [found.find(i) for i in range(len(fp))] == roots_of(fp, owned)
    assert [len(x) for x in S.shard_links(fp[:0], owned[:0])] == [0, 0]


def test_links_of_a_large_group_with_satellites(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 40)
    fp = group_and_satellites(0, 200, 1500, 2000)
    distinct = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    found, place = Groups(len(fp)), {int(x): i for i, x in enumerate(fp)}
    for r in S.links(distinct, len(fp)).collect():
        found.unite(place[r["a"]], place[r["b"]])
    assert [found.find(i) for i in range(len(fp))] == roots_of(fp, np.ones(len(fp), bool))


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect())
    groups = Groups(len(rows))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                groups.unite(i, j)
    for i, (doc, fp) in enumerate(rows):
        assert out[doc]["fingerprint"] == f"{fp:016x}" and out[doc]["component_id"] == rows[groups.find(i)][0]


def test_near_duplicate_edge_cases(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (5, text), (7, None), (8, ""), (9, " \n"), (None, text), (None, "alone text without any id"), (10, "word " * 30000)]
    out = S.near_duplicates(make_docs(rows))
    assert out.count() == len(rows)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out.collect()}
    assert {c for (d, _), c in by.items() if d in (3, 5)} == {3} and {c for (d, _), c in by.items() if d in (7, 8, 9)} == {7}
    kept = S.keep_one(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["10", "3", "7", "None"]
    assert S.near_duplicates(make_docs([])).count() == 0 and S.keep_one(make_docs([])).count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    groups = Groups(2200)
    for a, b in links:
        groups.unite(a, b)
    out = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x: groups.find(x) for x in nodes}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_drops(rows):
    """doc_id -> dropped lines, every line with a word compared with every other."""
    lines = sorted({(d, i, " ".join(x.lower().split())) for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n")) if x.strip()})
    forms = sorted({f for _, _, f in lines})
    grams, groups = [{f[i : i + 8] for i in range(len(f) - 7)} for f in forms], Groups(len(forms))
    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                groups.unite(i, j)
    at, seen, out = {f: i for i, f in enumerate(forms)}, set(), {}
    for d, i, f in lines:
        root = groups.find(at[f])
        if root in seen:
            out.setdefault(d, []).append(i)
        seen.add(root)
    return out


def test_line_drops_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = brute_drops([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: [int(x) for x in r["dropped"].split(",")] for r in queries.op8_line_dedup(spark, sf).collect() if r["dropped"]}
    assert got == wanted and len(wanted) > 5


def test_short_lines_and_lines_without_blanks(spark, make_docs):
    passage = "これは空白のない長い一行であり、単語の数では短い行と見なされてしまうものです"
    rows = [(1, f"}}\nAll rights reserved.\n{passage}\nabcdefgh"), (2, f" }}\nall  rights reserved.\n \n{passage}。\nAbcdefgh\nabcdefgi"), (3, "}\n\nown"), (4, "}\n}"), (5, " \n")]
    out = {r["doc_id"]: r["dropped"] for r in L.report(make_docs(rows)).collect()}
    assert out == {1: "", 2: "0,1,3,4", 3: "0", 4: "0,1", 5: ""}
    assert {r["doc_id"]: r["text"] for r in L.dedup(make_docs(rows)).collect()} == {1: rows[0][1], 2: " \nabcdefgi", 3: "\nown", 5: " \n"}


def test_bands_recall_at_the_threshold():
    rng = random.Random(8)
    found = total = 0
    while total < 150:
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(40)] = "zzzzz"
        a, b = " ".join(words), " ".join(other)
        if L.jaccard(L.shingles(a), L.shingles(b)) < 0.8:
            continue
        total += 1
        x = L.bands([a, b])
        found += bool((x[0] == x[1]).any())
    assert found >= 0.97 * total


def test_band_of_last_line_and_single_line():
    form = "the last line of a batch counts whole"
    assert (L.bands([form])[0] == L.bands(["another line that comes first here", form])[1]).all()
    assert (L.bands([form])[0] == L.bands([form, "another line that comes after it"])[0]).all()


def test_line_dedup_edge_cases(spark, make_docs):
    line = "this line is long enough to take part in it all"
    near = line.replace("enough", "enougH") + "!"
    rows = [(1, f"{line}\nshort\n"), (2, f"own words of the second document are here\n{near}"), (3, line), (3, line), (4, None), (5, ""), (None, line), (6, f"{line}\n{line}\nshort\nsix"), (7, "word " * 40000)]
    out = {r["doc_id"]: r for r in L.report(make_docs(rows)).collect()}
    assert out[1]["dropped"] == "" and out[2]["dropped"] == "1" and out[3]["dropped"] == "0" and out[6]["dropped"] == "0,1,2" and out[4]["n_lines"] == 1
    kept = L.dedup(make_docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "4", "5", "6", "7", "None"]
    six = next(r for r in kept if r["doc_id"] == 6)
    assert six["text"] == "six" and six["n_chars"] == 3 and six["key"] == "x"
    assert L.report(make_docs([])).count() == 0 and L.dedup(make_docs([])).count() == 0


def test_names_that_operators_use_inside(spark):
    names = ["own_doc_id", "dropped", "rest", "root", "h", "Text_Key", "near_id", "fp", "component_id", "rid"]
    ddl = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    text = "a line of words that stands in two documents as it is"
    docs = spark.createDataFrame([(1, text, 1, *names), (2, f"{text}\nown line of the second one", 2, *names)], ddl)
    kept = L.dedup(docs).collect()
    assert [(r["doc_id"], r["text"]) for r in sorted(kept)] == [(1, text), (2, "own line of the second one")]
    one = S.keep_one(docs.withColumn("text", F.lit(text))).collect()
    assert [r["doc_id"] for r in one] == [1]
    for r in kept + one:
        assert list(r.asDict()) == docs.columns and [r[n] for n in names] == names


def test_residue_links_lines_that_miss_the_lead(spark):
    import pyarrow as pa

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    lead = " ".join(base)
    other = ["".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(10)]
    x, y = " ".join(base[:55] + other[5:]), " ".join(base[:50] + other)
    j = lambda a, b: L.jaccard(L.shingles(a), L.shingles(b))
    assert j(lead, x) >= 0.8 > j(lead, y) and j(x, y) >= 0.8
    rows = [(1, 11, j(lead, x), x), (1, 12, j(lead, y), y), (2, 13, 0.1, lead), (2, 14, 0.1, y)]
    made = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "h", "j", "form"])
    assert [(r["a"], r["b"]) for b in L._residue(iter([made])) for r in b.to_pylist()] == [(12, 11)]


@pytest.mark.parametrize("few", [0, 24])
def test_bucket_links_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    rng = random.Random(11)
    for _ in range(60):
        base = [[rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(rng.randrange(40)) for _ in range(20)] for _ in range(3)]
        forms = []
        for _ in range(12):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(20)] = f"new{rng.randrange(90)}"
            forms.append(" ".join(words))
        lead = forms[0]
        j = lambda a, b: L.jaccard(L.shingles(a), L.shingles(b))
        members = [(i, j(f, lead), f) for i, f in enumerate(forms) if i]
        groups, wanted = Groups(12), Groups(12)
        for i, k, _ in members:
            if k >= 0.8:
                groups.unite(0, i)
        for a, b in L.bucket_links(members):
            groups.unite(a, b)
        for i in range(12):
            for k in range(i):
                if j(forms[i], forms[k]) >= 0.8:
                    wanted.unite(i, k)
        assert [groups.find(i) for i in range(12)] == [wanted.find(i) for i in range(12)]


def test_like_lines_of_a_bucket_that_do_not_link_are_hardly_compared(monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(60)]
    forms = [" ".join(word() if rng.random() < 0.2 else w for w in base) for _ in range(200)]
    forms.append(forms[100] + "!")
    members = [(i, 0.6, form) for i, form in enumerate(forms)]
    calls, exact = [], L.jaccard
    monkeypatch.setattr(L, "jaccard", lambda a, b: calls.append(1) or exact(a, b))
    assert L.bucket_links(members) == [(200, 100)]
    assert len(calls) < 100  # of 20,100 pairs


@pytest.mark.parametrize("few", [0, 4096])
@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x5200))) + "\U0001f600"])
def test_bucket_links_in_any_script(monkeypatch, few, letters):
    monkeypatch.setattr(L, "FEW", few)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    base = [word() for _ in range(50)]
    forms = [" ".join(base)]
    for _ in range(40):
        words = rng.choice(forms).split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(50)] = word()
        forms.append(" ".join(words))
    j = lambda a, b: L.jaccard(L.shingles(a), L.shingles(b))
    lead, groups, wanted = forms[0], Groups(41), Groups(41)
    members = [(i, j(f, lead), f) for i, f in enumerate(forms) if i]
    for i, k, _ in members:
        if k >= 0.8:
            groups.unite(0, i)
    links = L.bucket_links(members)
    for a, b in links:
        assert j(forms[a], forms[b]) >= 0.8
        groups.unite(a, b)
    for i in range(41):
        for k in range(i):
            if j(forms[i], forms[k]) >= 0.8:
                wanted.unite(i, k)
    assert links and [groups.find(i) for i in range(41)] == [wanted.find(i) for i in range(41)]


def test_sets_of_numbers_measure_as_sets_of_strings():
    rng = random.Random(14)
    narrow = ["".join(rng.choice("abé —я") for _ in range(rng.randrange(8, 40))) for _ in range(60)] + ["aaaaaaaa", "a" * 60_000]
    wide = narrow + ["".join(map(chr, range(0x4E00, 0x4F00)))]
    for forms, kind in ((narrow, np.ndarray), (wide, frozenset)):
        sets = L.shingle_sets(forms)
        assert all(isinstance(s, kind) for s in sets)
        for x, a in zip(forms, sets, strict=True):
            for y, b in zip(forms, sets, strict=True):
                assert L.jaccard(a, b) == L.jaccard(L.shingles(x), L.shingles(y))


def test_lines_of_a_text_are_normal():
    rng = random.Random(15)
    for letters in ("aB \n", "aΣς. \nİ", "a \n\t", "a\u3000\x85 \n", "Ab\x1c\r \n"):
        for _ in range(300):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
            assert L.normal_lines(text) == [L.normal(line) for line in text.split("\n")]
