import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import license_scan as L
from textloom.llm import quality_model as M
from textloom.llm import sharding as S


def brute_table(shards, size):
    """The table by full preference lists."""
    import hashlib

    lists = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        lists.append(iter([(offset + j * skip) % size for j in range(size)]))
    slots = {}
    while len(slots) < size:
        for i, own in enumerate(lists):
            if len(slots) < size:
                slots[next(s for s in own if s not in slots)] = i
    return [slots[i] for i in range(size)]


def test_table_equals_brute_force():
    for size, n in ((7, 3), (13, 13), (101, 5)):
        shards = [f"s{i}" for i in range(n)]
        assert S.build_table(shards, size).tolist() == brute_table(shards, size)


def test_table_is_even_and_moves_little():
    shards = [f"s{i}" for i in range(20)]
    table = S.build_table(shards)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = S.build_table(shards[:-1])
    assert (table != less).mean() < 0.12  # a twentieth must move
    heavy = np.bincount(S.build_table(shards, weights=[3] + [1] * 19))
    assert 2.5 < heavy[0] / heavy[1:].mean() < 3.5


def test_assign_edge_cases(spark, make_docs, tmp_path):
    shards = [f"s{i}" for i in range(4)]
    docs = make_docs([(1, "a"), (1, "b"), (None, "c"), (None, None)])
    out = S.assign(docs, "doc_id", shards).collect()
    assert len(out) == 4 and len({(r["doc_id"], r["shard"]) for r in out}) == 2
    assert S.assign(make_docs([]), "doc_id", shards).count() == 0
    S.write_shards(docs.withColumn("shard", docs.doc_id), "doc_id", shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    for bad in ([], ["a", "a"]):
        try:
            S.build_table(bad)
            raise AssertionError
        except ValueError:
            pass


@pytest.mark.parametrize("key", ["slot", "shard", "doc_id", "Shard"])
def test_shards_of_keys_and_columns_of_any_name(spark, tmp_path, key):
    names = list(dict.fromkeys([key, "_slot", "_shard", "salt", "slots"]))
    df = spark.createDataFrame([(i, *[f"v{i}"] * (len(names) - 1)) for i in range(20)], ", ".join(f"`{n}` {'long' if n == key else 'string'}" for n in names))
    wanted = {r[0]: r[1:] for r in S.assign(spark.range(20).withColumnRenamed("id", "k"), "k", ["a", "b", "c"]).collect()}
    slot, shard = S.result_names(key)
    out = S.with_shard(df, key, ["a", "b", "c"])
    assert out.columns == [*names, slot, shard] and len({c.lower() for c in out.columns}) == len(names) + 2
    for r in out.collect():
        assert tuple(r)[len(names) :] == wanted[r[key]] and list(r)[1 : len(names)] == [f"v{r[key]}"] * (len(names) - 1)
    assert {r[0]: r[1:] for r in S.assign(df, key, ["a", "b", "c"]).collect()} == wanted
    S.write_shards(df, key, ["a", "b", "c"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in M.score(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    held = [(out[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.95 and np.mean([(s >= 0.5) == q for s, q in held]) > 0.9


def test_training_never_sees_held_out_rows(spark, make_docs):
    docs = make_docs([(i, f"text number {i}") for i in range(50)] + [(None, "x")])
    twice = next(i for i in range(1, 50, 2) if zlib.crc32(str(i).encode()) % 3 != 1)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (twice, 0, 0)], "doc_id long, quality int, toxic int")
    rows = M.training_rows(docs, labels).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert next(r["quality"] for r in rows if r["doc_id"] == twice) == 0
    assert len(M.training_rows(docs, labels, 7).collect()) == 7


def plain_fit_and_score(rows, texts, epochs):
    """The model without numpy's indexing: a dictionary of vectors, one feature at a time, in the order that `fit` draws."""
    rng = np.random.default_rng(M.SEED)
    vectors = rng.uniform(-1 / 4, 1 / 4, (M.BUCKETS, 4)).astype(np.float32)
    share = np.float32(np.mean([y for y, _, _ in rows]))
    out, constant = np.zeros((4, 2)), np.log([1 - share, share])
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, weights = rows[i]
            step = M.RATE * (1 - done / (epochs * len(rows)))
            done += 1
            mean = sum(w * vectors[b].astype(float) for b, w in zip(buckets, weights, strict=True))
            z = [float(mean @ out[:, k] + constant[k]) for k in (0, 1)]
            p = [np.exp(v) / sum(map(np.exp, z)) for v in z]
            error = [p[k] - (k == label) for k in (0, 1)]
            pull = out[:, 0] * error[0] + out[:, 1] * error[1]
            for k in (0, 1):
                out[:, k] -= step * mean * error[k]
                constant[k] -= step * 0.1 * error[k]
            for b, w in zip(buckets, weights, strict=True):
                vectors[b] -= step * w * pull
    scores = []
    for text in texts:
        buckets, weights = M.document(text.encode(), M.WordHashes())
        mean = sum((w * vectors[b].astype(float) for b, w in zip(buckets, weights, strict=True)), np.zeros(4))
        z = mean @ out + constant
        scores.append(float(1 / (1 + np.exp(z[0] - z[1]))))
    return scores


def brute_features(text):
    """Counts of words, pairs and character 3- to 5-grams, each by its own value and not by a bucket."""
    words = text.split()
    found = Counter(words) + Counter(zip(words, words[1:], strict=False))
    for w in words:
        for n in (3, 4, 5):
            found.update(("gram", f" {w} "[i : i + n]) for i in range(len(w) + 3 - n))
    return found


def test_features_and_fit_equal_brute_force():
    texts = ["good plain words of a tale", "bad *** junk ### bad", "plain words good", "junk junk *** x"] * 3
    for t in [*texts, "", "é", "日本 語 ab", "one"]:
        buckets, weights = M.document(t.encode(), M.WordHashes())
        wanted = brute_features(t)
        assert abs(sum(weights) * max(len(t.split()), 1) - sum(wanted.values())) < 1e-3 and len(buckets) <= len(wanted)
    rows = [(1 - i % 2, *M.document(t.encode(), M.WordHashes())) for i, t in enumerate(texts)]
    share, constant = M.fit(rows, 5, M.RATE, 4)
    wanted = plain_fit_and_score(rows, texts, 5)
    for t, w in zip(texts, wanted, strict=True):
        buckets, weights = M.document(t.encode(), M.WordHashes())
        assert abs(1 / (1 + np.exp(-(constant + float(weights @ share[buckets])))) - w) < 1e-3


def test_rows_that_repeat_a_training_id_train_once(spark, make_docs):
    rows = [(i, "good plain words" if i < 20 else "### bad *** junk") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = make_docs(rows + [(0, f"another text {k}") for k in range(50)] + rows)
    out = M.training_rows(many, labels).collect()
    assert len(out) == len({r["doc_id"] for r in out}) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert sorted(map(tuple, out)) == sorted(map(tuple, M.training_rows(many.repartition(3), labels).collect()))


def test_quality_model_edge_cases(spark, make_docs):
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "good plain words" if i < 20 else "### bad *** junk") for i in range(40)] + [(100, None), (101, ""), (100, None), (None, "good plain words"), (102, "w" * 100_000)]
    out = M.score(make_docs(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[100] == by[101] and by[1] > 0.5 > by[30] and by[None] == by[1]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in M.score(make_docs(rows), none).collect()} == {0.5}
    assert M.score(make_docs([]), none).count() == 0


def brute_license(paragraph):
    classes, weights, biases, temperature = L.model()
    z = np.array(biases)
    for g in L.grams_of(L.words_of(paragraph)):
        if g in weights:
            z = z + np.array(weights[g])
    z = z / temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    family = classes[int(p.argmax())] if p.max() >= L.MIN_PROBABILITY else L.UNKNOWN
    own = set(L._bigrams(L.words_of(paragraph)))
    sure = False
    for c, t in L.templates():
        shared = own & set(t)
        sure |= c == family and len(shared) >= min(2, len(t)) and len(shared) >= 0.5 * min(len(own), len(t))
    return family, round(float(p.max()), 6), sure


def test_license_scores_equal_brute_force(spark):
    lines = [t for own in L.NOTICES.values() for t in own] + L.OTHER + ["", "MIT", "a licensed word", "Licensed under the Apache Licence 2.0 by Ünal", "license " * 3000]
    lines = list(dict.fromkeys(lines))
    out = L.classify(spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "rid long, number int, paragraph string")).collect()
    assert len(out) == len(lines)
    for r in out:
        family, p, sure = brute_license(lines[r["rid"]])
        assert (r["family"], r["confirmed"]) == (family, sure) and abs(r["probability"] - p) < 1e-5


def test_license_families_and_unknown():
    for family, own in L.NOTICES.items():
        for t in own:
            assert brute_license(t)[0] == family and brute_license("Note of Jane Doe: " + t)[2], t
    assert all(not brute_license(t)[2] for t in ["She had no permission to leave.", "The licence of the pilot was renewed.", "Er kam mit dem Rad."])


def test_license_recall_and_calibration_on_held_out_notices():
    """Rows of notices, frames and sentences that the scoring model never met; copies as they stand in the source."""
    classes, labels, rows, _ = L.examples()
    source = {tuple(L.words_of(t)) for own in [*L.NOTICES.values(), L.OTHER] for t in own} | {tuple(L.words_of(f.format(n))) for own in L.NAMES.values() for n in own for f in L.FRAMES}
    whole = np.array([tuple(r) in source for r in rows])
    p = L.probabilities(L.held_out(), L.model()[3])[whole]
    labels, unknown = labels[whole], classes.index(L.UNKNOWN)
    said = np.where(p.max(axis=1) >= L.MIN_PROBABILITY, p.argmax(axis=1), unknown)
    licensed = labels != unknown
    assert (said == labels)[licensed].mean() >= 0.9 and (said == labels)[~licensed].mean() >= 0.9
    sure = p.max(axis=1) >= 0.9
    assert (p.argmax(axis=1) == labels)[sure].mean() >= 0.9


def test_license_gate_lets_every_notice_through(spark):
    lines = [t for own in L.NOTICES.values() for t in own] + [f.format(n) for own in L.NAMES.values() for n in own for f in L.FRAMES]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, text string").select("i", L.paragraphs(F.col("text")).alias("p")).collect()
    assert all(r["p"] == [lines[r["i"]]] for r in out)


def wrap(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_wrapped_and_commented_notices_are_found_whole(spark, make_docs):
    rows, wanted = [], []
    for family, own in L.NOTICES.items():
        for t in own:
            for width, mark in ((70, ""), (76, " * "), (72, "# "), (80, "// ")):
                rows.append((len(rows), f"Some words before.\n\n{wrap(t, width, mark)}\n\nSome words after."))
                wanted.append(family)
    out = {r["doc_id"]: r for r in L.scan(make_docs(rows)).collect()}
    assert np.mean([wanted[i] in out[i]["families"].split(",") for i in out]) >= 0.97
    grant = wanted.index("mit")
    assert out[grant]["families"] == "mit" and out[grant]["n_paragraphs"] == 1


def test_license_scan_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "text\nReleased under the MIT License.\nmore"), (3, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved. " + "word " * 30000), (4, "a fishing licence\nReleased under the MIT License.")]
    out = L.scan(make_docs(rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["best"] == by[2]["best"] == "none" and by[4]["best"] == "mit" and by[4]["n_unknown"] == 1
    assert sorted((r["families"], r["n_paragraphs"]) for r in out if r["doc_id"] == 3) == [("cc-by-nc", 1), ("mit", 1)]
    assert L.scan(make_docs([])).count() == 0


def test_license_scan_runs_no_python(spark, make_docs):
    plan = L.scan(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_shards_of_documents_are_even(spark, sf):
    out = S.assign(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", ["a", "b"]).collect()
    assert min(Counter(r["shard"] for r in out).values()) > 60
